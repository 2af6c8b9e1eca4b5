"""Writers for result tables and creation intents."""
