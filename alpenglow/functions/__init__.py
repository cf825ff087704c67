"""Statistics, least squares and global order."""
