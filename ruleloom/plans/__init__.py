"""ruleloom.plans"""
