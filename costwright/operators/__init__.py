"""Cost questions, findings, recommendations, forecasts, policy and reports."""
