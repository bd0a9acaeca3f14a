"""Where data comes from and goes to: projects, image chunks, fusion containers, points."""
