"""Column expressions: lists, text, detectors, risk and intents."""
