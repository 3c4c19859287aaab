"""seqspark.streaming"""
