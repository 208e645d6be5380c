"""orpheon.streaming"""
