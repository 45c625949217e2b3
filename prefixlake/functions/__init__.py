"""Column functions: address bits, text, JSON, hashes and ranking keys."""
