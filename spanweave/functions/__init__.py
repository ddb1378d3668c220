"""spanweave.functions"""
