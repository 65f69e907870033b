"""envmon.functions"""
