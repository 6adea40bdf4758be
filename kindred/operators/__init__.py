"""kindred.operators"""
