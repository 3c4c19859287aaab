"""seqspark.functions"""
