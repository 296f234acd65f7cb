"""ruleloom.functions"""
