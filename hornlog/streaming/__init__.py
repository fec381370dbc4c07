"""Evaluation over growing inputs."""
