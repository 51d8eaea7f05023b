"""fundspark.plans"""
