"""caselight.sources"""
