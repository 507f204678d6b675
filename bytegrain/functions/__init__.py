"""Column expressions over binary payloads."""
