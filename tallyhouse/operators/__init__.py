"""Set-based operators over shop tables."""
