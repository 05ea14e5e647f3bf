"""Reading, upserting and incremental loads."""
