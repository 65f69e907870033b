"""envmon.streaming"""
