"""End-to-end jobs: SFT preparation, prompt preparation and scoring."""
