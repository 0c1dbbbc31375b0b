"""Line files, pose files and frame streams as tables, and their writers."""
