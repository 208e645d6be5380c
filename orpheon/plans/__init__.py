"""orpheon.plans"""
