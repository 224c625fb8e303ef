"""Part of quillon."""
