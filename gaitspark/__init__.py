"""Trajectory analytics on Spark: movement episodes, kinematics, interaction, retrieval."""
