"""rillflow: a Spark-native data plane for reinforcement-learning post-training.

Prompts, sampled responses, token-level signals and conversation logs are plain
DataFrames; every operator is a function from DataFrames to DataFrames.
"""
