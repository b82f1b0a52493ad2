"""What is written: lines of each format, files and folders of them, indexes, metrics."""
