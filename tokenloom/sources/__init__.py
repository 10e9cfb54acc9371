"""Vocabulary files and raw inputs."""
