"""Readers, writers and prepared inputs."""
