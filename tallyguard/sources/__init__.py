"""Reading arrivals and publishing table snapshots."""
