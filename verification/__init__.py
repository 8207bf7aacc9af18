"""The registered queries and, independently written, their SQL counterparts."""
