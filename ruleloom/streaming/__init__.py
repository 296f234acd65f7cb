"""ruleloom.streaming"""
