"""orpheon.operators"""
