"""orpheon.sources"""
