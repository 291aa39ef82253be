"""Pulling tensors one by one."""
