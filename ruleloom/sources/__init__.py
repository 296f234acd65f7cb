"""ruleloom.sources"""
