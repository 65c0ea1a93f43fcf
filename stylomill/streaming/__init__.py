"""stylomill.streaming"""
