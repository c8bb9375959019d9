"""Reading page, material and asset tables; keyed and idempotent writes."""
