"""seqspark.plans"""
