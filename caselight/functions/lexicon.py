"""Pattern and term lists of the document operators. All are parameters: pass longer lists to extend them."""

from __future__ import annotations

# The lists below define the results and are stated as they have to be.

JUNK_EN = [
    r"^\s*page\s+\d+\s*(of\s*\d+)?\s*$",
    r"^\s*-?\s*\d+\s*-?\s*$",
    r"^\s*www\.\S+\s*$",
    r"^\s*supreme\s*court\s*of\s*bangladesh\s*$",
    r"^\s*high\s*court\s*division\s*$",
]

JUNK_BN = [
    r"^\s*page\s+\d+\s*(of\s*\d+)?\s*$",
    r"^\s*পৃষ্ঠা\s*\d+\s*$",
    r"^\s*-?\s*\d+\s*-?\s*$",
    r"^\s*www\.\S+\s*$",
    r"^\s*সুপ্রিম\s*কোর্ট.*$",
]

SECTIONS = {
    "facts": [
        r"^\s*facts?\b",
        r"^\s*statement of facts",
        r"^\s*background\b",
        r"^\s*brief facts",
        r"^\s*facts? of the case",
        r"^\s*the (short|brief) facts",
        r"^\s*facts? leading to",
        r"^\s*this (rule|appeal|revision|petition|application) (was issued|is directed against|arises)",
        r"^\s*by this (application|petition|rule)",
        r"the (prosecution|plaintiff|petitioner|appellant)('s)?\s*case,?\s*in brief,?\s*(is|was)\s*that",
        r"the fact(s)? of the case,?\s*in brief,?\s*(is|are|was|were)\s*that",
    ],
    "arguments": [
        r"^\s*submissions?\b",
        r"^\s*arguments?\b",
        r"^\s*submissions? of the parties",
        r"^\s*contentions?\b",
        r"^\s*heard the learned",
        r"^\s*mr\.?\s+\w+.*(learned advocate|learned counsel)",
        r"^\s*ms\.?\s+\w+.*(learned advocate|learned counsel)",
        r"learned (advocate|counsel) (for|appearing for) the (petitioner|appellant|respondent|opposite party|state)",
        r"^\s*having heard the learned",
        r"^\s*learned counsel for (both|the) (sides|parties)",
        r"^\s*per contra,?\b",
        r"^\s*mr\.?\s+\w+.*(contended|submitted|argued) that",
        r"^\s*ms\.?\s+\w+.*(contended|submitted|argued) that",
    ],
    "order": [
        r"^\s*judgment\b",
        r"^\s*order\b",
        r"^\s*decision\b",
        r"^\s*findings? and order",
        r"^\s*discussion and findings?",
        r"^\s*conclusion\b",
        r"^\s*in the result",
        r"^\s*accordingly,?\b",
        r"^\s*in view of the above",
        r"^\s*for the reasons stated above",
        r"^\s*the rule is (made absolute|discharged)",
        r"^\s*it is ordered that",
        r"^\s*this (rule|appeal|revision|petition) is (allowed|dismissed|disposed)",
    ],
}

ORDER_MARKERS = ["অর্ডার", "আদেশ", "রায়ের শেষাংশ", "ফলে", "ফলস্বরূপ", "তদনুসারে", "সুতরাং", "অতএব", "বিধি", "আপিল"]

DECISION = [
    r"\brule is made absolute\b",
    r"\brule made absolute\b",
    r"\brule is made absolute in part\b",
    r"\brule is made absolute in part and discharged in part\b",
    r"\brule is discharged\b",
    r"\brule is disposed of\b",
    r"\brule stands discharged\b",
    r"\brule stands absolute\b",
    r"\bfind merit in\b",
    r"\ballowed\b",
    r"\bdismissed\b",
    r"\bdischarged\b",
    r"\brejected\b",
    r"\baffirmed\b",
    r"\bset[\s-]*aside\b",
    r"\bmodified\b",
    r"\bcommuted\b",
    r"\bacquitted\b",
    r"\bconviction\b",
    r"\bsentence\b",
    r"\bdisposed of\b",
    r"\bstands recalled\b",
    r"\bstands vacated\b",
    r"\bis hereby directed\b",
    r"\bwe direct\b",
    r"\bno order as to costs\b",
    r"খারিজ",
    r"মঞ্জুর",
    r"আদেশ",
    r"নির্দেশ",
]

REASONING = [
    r"in view of",
    r"from the above discussion",
    r"we are of the view",
    r"this court is.*satisfied",
    r"we find",
    r"we hold",
    r"therefore",
    r"thus",
    r"consequently",
    r"for the reasons",
    r"accordingly",
]

ABBREVIATIONS = ["No.", "Nos.", "Mr.", "Mrs.", "Dr.", "J.", "Ltd."]

FACT_MARKERS = [
    "relevant facts", "facts for disposal", "facts leading", "brief facts", "short facts", "admitted facts",
    "undisputed facts", "facts emerging", "facts of the case", "case of the petitioner", "case of the prosecution",
    "factual background",
]
FACT_EXCLUDE = [
    "supreme court of bangladesh", "high court division", "present:", "heard on", "judgment on", "for the petitioner",
    "for the respondent", "learned advocate submits", "learned advocate contends",
]
FACT_SIGNALS = [
    "it is undisputed", "it is admitted", "admitted position", "it appears from the record", "the petitioner joined",
    "the petitioner retired", "was arrested", "was convicted", "was filed", "filed the instant", "was registered",
    "occurred on", "the company failed", "the materials on record disclose", "respondents refrained",
    "pension benefits", "audit objection", "share transfer",
]

ISSUE_MARKERS = [
    "issues arise for determination", "issue arises for determination", "issue for determination",
    "issues for determination", "question for determination", "questions for determination",
    "question requiring determination", "point for determination", "required to examine", "requires determination",
    "the question is whether", "the issue is whether",
]
ISSUE_FOLLOWERS = ["whether", "issue no", "firstly", "secondly"]
ISSUE_HEADINGS = ["issue no.", "issue no "]
ISSUE_COUNSEL = ["learned advocate", "he submits", "she submits", "counsel submits"]

LEGAL_BASIS = [
    r"\bsections?\s+\d",
    r"\barticles?\s+\d",
    r"\border\s+[ivxlcdm0-9]+\s+rule",
    r"\brule\s+\d",
    r"\b[a-z][a-z\s’'\-]+act,\s*\d{4}",
    r"\bcode of\b",
    r"\bconstitution\b",
    r"\bordinance\b",
    r"\bpension simplification order,\s*\d{4}",
    r"\bservice rules?\s+(?:of\s+)?\d{4}",
]
LEGAL_EXCLUDE = [
    "rule is made absolute", "rule is discharged", "rule stands discharged", "rule is disposed",
    "no order as to costs", "communicate the judgment", "learned advocate prays",
]

COURT_SIGNALS = [
    "we are of the view", "we find that", "we find", "this court finds", "this court is satisfied",
    "court is satisfied", "we hold", "we observe", "we are unable to accept", "it is obvious", "it is evident",
    "it appears that", "it transpires", "therefore", "thus", "consequently", "in view of the findings",
    "in view of the discussion", "from the above discussion", "cannot be relied upon", "without any lawful authority",
]
COUNSEL_SIGNALS = [
    "learned advocate submits", "learned advocate contends", "learned advocate argued", "learned senior advocate",
    "he submits", "she submits", "he argued", "she argued", "he contends", "she contends", "prays for", "prayer is",
]

PROMPT_HEAD = """
You are a legal explanation assistant.

Your task is to explain the court judgment in clear, simple Bangla.

IMPORTANT RULES:
1. Use ONLY the evidence provided below.
2. Do NOT invent facts, laws, arguments, reasons, or decisions.
3. If evidence for a component is insufficient, write:
   "পর্যাপ্ত প্রমাণ পাওয়া যায়নি।"
4. Preserve the meaning of the court's decision exactly.
5. Do not give legal advice.
6. Keep each section concise.
7. Legal Act names, section numbers and case-specific identifiers may remain in English.

CASE ID:
"""
PROMPT_BLOCKS = [
    ("\n\nFACT EVIDENCE:\n", "fact_evidence"),
    ("\n\nLEGAL ISSUE EVIDENCE:\n", "legal_issue_evidence"),
    ("\n\nLEGAL BASIS EVIDENCE:\n", "legal_basis_evidence"),
    ("\n\nCOURT REASONING EVIDENCE:\n", "court_reasoning_evidence"),
    ("\n\nCOURT DECISION EVIDENCE:\n", "court_decision_evidence"),
]
PROMPT_TAIL = """

Return ONLY valid JSON in exactly this format:

{
  "facts": "সহজ বাংলায় মামলার গুরুত্বপূর্ণ ঘটনা",
  "legal_issue": "আদালতের সামনে মূল আইনি প্রশ্ন",
  "legal_basis": "প্রযোজ্য আইন, ধারা বা বিধান",
  "court_reasoning": "আদালত কেন এই সিদ্ধান্তে পৌঁছেছে",
  "decision": "আদালতের চূড়ান্ত সিদ্ধান্ত",
  "plain_bangla_explanation": "২-৪ বাক্যে পুরো মামলার সহজ বাংলা ব্যাখ্যা"
}
"""
EXPLANATION_FIELDS = ["facts", "legal_issue", "legal_basis", "court_reasoning", "decision", "plain_bangla_explanation"]

EDGE_PUNCTUATION = "।,.()[]{}:;\"'—-"
NUMERIC = r"[０-９0-9০-৯]+(?:[.,][０-９0-9০-৯]+)*"
