"""envmon.operators"""
