"""Where inventories come from and are kept."""
