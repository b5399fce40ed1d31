"""Session set-up, scratch tables and plan inspection."""
