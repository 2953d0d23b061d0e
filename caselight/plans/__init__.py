"""caselight.plans"""
