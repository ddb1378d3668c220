"""spanweave.plans"""
