"""Where documents and findings go."""
