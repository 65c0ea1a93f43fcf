"""stylomill.functions"""
