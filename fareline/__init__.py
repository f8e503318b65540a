"""Composable DataFrame operators for transit analytics and training-data preparation."""
