"""caselight.operators"""
