"""Column functions: text, metrics, prompts, outlines, style."""
