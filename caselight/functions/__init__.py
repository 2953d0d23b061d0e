"""caselight.functions"""
