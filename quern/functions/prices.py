"""Prices of models."""

#: USD for a million tokens of input, output and cache reads, by model.
MODEL_PRICES = (
    ("claude-haiku-4-5-20251001", 0.80, 4.00, 0.08), ("claude-sonnet-4-20250514", 3.00, 15.00, 0.30), ("claude-opus-4-20250115", 15.00, 75.00, 1.50),
    ("gpt-4o", 2.50, 10.00, 0.0), ("gpt-4o-mini", 0.15, 0.60, 0.0), ("gpt-4.1", 2.00, 8.00, 0.0), ("gpt-4.1-mini", 0.40, 1.60, 0.0), ("gpt-4.1-nano", 0.10, 0.40, 0.0),
    ("o1", 15.00, 60.00, 0.0), ("o3-mini", 1.10, 4.40, 0.0), ("gemini-2.0-flash", 0.10, 0.40, 0.0), ("gemini-2.5-pro", 1.25, 10.00, 0.0), ("gemini-2.5-flash", 0.15, 0.60, 0.0),
    ("qwen-turbo", 0.30, 0.60, 0.0), ("qwen-plus", 0.80, 2.00, 0.0), ("qwen-max", 2.00, 6.00, 0.0), ("qwen-vl-plus", 0.80, 2.00, 0.0), ("qwen-vl-max", 2.00, 6.00, 0.0), ("qwen-long", 0.50, 2.00, 0.0),
    ("grok-3", 3.00, 15.00, 0.0), ("grok-3-mini", 0.30, 0.50, 0.0), ("grok-4-0709", 3.00, 15.00, 0.0), ("grok-3-fast", 5.00, 25.00, 0.0), ("grok-3-mini-fast", 0.60, 4.00, 0.0),
)
#: The price of a model that isn't listed, and the prefix of those that run on one's own machine for free.
DEFAULT_PRICE = (3.0, 15.0, 0.3)
LOCAL_PREFIX = "ollama/"
