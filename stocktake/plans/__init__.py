"""The registered queries and the inventory that they run on."""
