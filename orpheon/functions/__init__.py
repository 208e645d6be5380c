"""orpheon.functions"""
