"""seqspark.operators"""
