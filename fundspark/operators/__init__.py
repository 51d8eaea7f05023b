"""fundspark.operators"""
