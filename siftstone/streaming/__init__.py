"""The pull-request monitor."""
