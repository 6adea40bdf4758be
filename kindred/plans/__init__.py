"""kindred.plans"""
