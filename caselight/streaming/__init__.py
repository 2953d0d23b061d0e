"""caselight.streaming"""
