"""Readers, adapters and profiling of inputs."""
