"""fundspark.functions"""
