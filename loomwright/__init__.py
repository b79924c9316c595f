"""Loomwright: corpus analytics declared as Spark DataFrame plans."""
