"""Part of jobmill."""
