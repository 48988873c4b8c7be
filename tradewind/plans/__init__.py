"""The modelled tables, the business queries and the ordered build."""
