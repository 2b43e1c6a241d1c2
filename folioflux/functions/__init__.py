"""Part of folioflux."""
