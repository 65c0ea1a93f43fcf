"""stylomill.sources"""
