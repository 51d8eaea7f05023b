"""fundspark.sources"""
