"""End-to-end jobs: what an analyst runs on posts and comments."""
