"""ruleloom.operators"""
