"""stylomill.operators"""
