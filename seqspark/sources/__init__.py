"""seqspark.sources"""
