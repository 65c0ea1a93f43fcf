"""stylomill.plans"""
