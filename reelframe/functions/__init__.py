"""Part of reelframe; see README.md."""
