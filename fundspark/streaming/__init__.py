"""fundspark.streaming"""
