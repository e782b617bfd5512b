"""Fixed values of bill-text extraction: keywords, labels and patterns, in the order they are tried."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """How one field is found: patterns are a value regex, or (anchor regex, value regex)."""

    field: str
    confidence: float
    transform: str | None
    patterns: list
    groups: dict | None = None
    multi: bool = False


# Extraction rules per provider.
PROVIDER_RULES: dict[str, list[Rule]] = {
    "Energia": [
        Rule("mprn", 0.95, "strip_spaces", [
            r"MPRN\s*(?:Number|No\.?|:)?\s*[:\s]*(\d[\d\s]{9,13}\d)",
            r"(?:MPRN|Meter\s*Point)[:\s#]*(\d{10,11})",
            r"\b(10\d{9})\b",
        ]),
        Rule("account_number", 0.9, "strip_spaces", [
            r"(?:Account|Acct|A/C)\s*(?:No|Number|#|Num)[:\s.]*(\d[\d\s]{6,12}\d)",
            r"Account\s*Number\s*\n?\s*(\d{7,})",
        ]),
        Rule("invoice_number", 0.85, None, [
            r"(?:Invoice|Bill)\s*(?:No|Number|#)\.?\s*[:\s]*(\d+)",
        ]),
        Rule("billing_period", 0.9, None, [
            r"(?:Billing|Bill|Accounting)\s*Period\s*[:\s]*(\d{1,2}\s+\w+\s+\d{4}\s*(?:to|-)\s*\d{1,2}\s+\w+\s+\d{4})",
            r"(?:Billing|Bill|Accounting)\s*Period\s*\n\s*(\d{1,2}\s+\w+\s+\d{4}\s*(?:to|-)\s*\d{1,2}\s+\w+\s+\d{4})",
            r"(?:Billing|Bill|Accounting)\s*Period\s*[:\s]*(\d{2}/\d{2}/\d{4})\s*[-–]\s*(\d{2}/\d{2}/\d{4})",
            r"(?:Billing|Bill|Accounting)\s*Period\s*\n?\s*(\d{2}/\d{2}/\d{4})\s*[-–]\s*(\d{2}/\d{2}/\d{4})",
            r"(?:Billing|Bill|Accounting)\s*Period\s*[:\s]*(\d{2}\.\d{2}\.\d{4})\s*[-–]\s*(\d{2}\.\d{2}\.\d{4})",
            r"(?:Billing|Bill|Accounting)\s*Period\s*\n?\s*(\d{2}\.\d{2}\.\d{4})\s*[-–]\s*(\d{2}\.\d{2}\.\d{4})",
        ]),
        Rule("invoice_date", 0.85, None, [
            r"(?:Invoice|Bill)\s*Date\s*[:\s]*(\d{1,2}\s+\w+\s+\d{4})",
            r"(?:Invoice|Bill)\s*Date\s*\n?\s*(\d{1,2}\s+\w+\s+\d{4})",
            (r"ACCOUNT\s*SUMMARY", r"Date\s*\n\s*(\d{1,2}\s+\w+\s+\d{4})"),
            r"Date\s+of\s+this\s+Bill\s*\n\s*(\d{1,2}\s+\w+\s+\d{4})",
            r"(?:Invoice|Bill)\s*Date\s*[:\s]*(\d{2}/\d{2}/\d{4})",
            r"(?:Invoice|Bill)\s*Date\s*[:\s]*(\d{2}\.\d{2}\.\d{4})",
        ]),
        Rule("day_kwh", 0.9, "strip_commas", [
            r"Day\s+(?:Energy|Rate)\s+(\d[\d,]*)\s*(?:kWh|xWh|XWh)",
            r"Day\s+Energy\n\s*(\d[\d,]*)\n\s*kWh",
            r"Day\s+(\d[\d,.]*)\s+Units?\s+at",
        ]),
        Rule("day_rate", 0.9, None, [
            r"Day\s+(?:Energy|Rate)\s+\d[\d,]*\s*(?:kWh|xWh)\s*@\s*[€\u20ac]?\s*(\d+\.\d+)",
            r"Day\s+Energy\n\s*\d[\d,]*\n\s*kWh\n\s*@\n\s*[€](\d+\.\d+)",
            r"Day\s+\d[\d,.]*\s+Units?\s+at\s+[€\u20ac](\d+\.\d+)",
        ]),
        Rule("day_cost", 0.85, None, [
            r"Day\s+(?:Energy|Rate)\s+\d[\d,]*\s*(?:kWh|xWh)\s*@\s*[€\u20ac]?\s*\d+\.\d+\s*[€\u20ac]\s*(\d+\.\d+)",
            r"Day\s+Energy\n\s*\d[\d,]*\n\s*kWh\n\s*@\n\s*[€]\d+\.\d+\n\s*[€](\d+\.\d+)",
            r"Day\s+\d[\d,.]*\s+Units?\s+at\s+[€\u20ac]\d+\.\d+\s+per\s+Unit\s*\n\s*[€\u20ac](\d[\d,]*\.\d{2})",
        ]),
        Rule("night_kwh", 0.9, "strip_commas", [
            r"Night\s+(?:Energy|Rate)\s+(\d[\d,]*)\s*(?:kWh|xWh|XWh)",
            r"Night\s+Energy\n\s*(\d[\d,]*)\n\s*kWh",
            r"Night\s+(\d[\d,.]*)\s+Units?\s+at",
        ]),
        Rule("night_rate", 0.9, None, [
            r"Night\s+(?:Energy|Rate)\s+\d[\d,]*\s*(?:kWh|xWh)\s*@\s*[€\u20ac]?\s*(\d+\.\d+)",
            r"Night\s+Energy\n\s*\d[\d,]*\n\s*kWh\n\s*@\n\s*[€](\d+\.\d+)",
            r"Night\s+\d[\d,.]*\s+Units?\s+at\s+[€\u20ac](\d+\.\d+)",
        ]),
        Rule("night_cost", 0.85, None, [
            r"Night\s+(?:Energy|Rate)\s+\d[\d,]*\s*(?:kWh|xWh)\s*@\s*[€\u20ac]?\s*\d+\.\d+\s*[€\u20ac]\s*(\d+\.\d+)",
            r"Night\s+Energy\n\s*\d[\d,]*\n\s*kWh\n\s*@\n\s*[€]\d+\.\d+\n\s*[€](\d+\.\d+)",
            r"Night\s+\d[\d,.]*\s+Units?\s+at\s+[€\u20ac]\d+\.\d+\s+per\s+Unit\s*\n\s*[€\u20ac](\d[\d,]*\.\d{2})",
        ]),
        Rule("standing_charge", 0.85, None, [
            r"Standing\s*Charge\s*\.?\s*(\d+)\.?\s*Days?\s*@\.?\s*#?[€\u20ac]?\s*(\d+\.\d+)\s*#?[€\u20ac]\s*(\d+\.\d+)",
            r"Standing\s+Charge\s*\n\s*(\d+)\s*\n\s*Days\s*\n\s*@\s*\n\s*[€]?(\d+\.\d+)\s*\n\s*[€](\d+\.\d+)",
            r"Standing\s+Charge\s+(\d+)\s+days?\s+at\s+[€\u20ac](\d+\.\d+)\s+per\s+day\s*\n\s*[€\u20ac](\d+\.\d+)",
        ], groups={"days": 1, "rate": 2, "total": 3}),
        Rule("pso_levy", 0.8, None, [
            r"Public\s+Service\s+Obligation\s+Levy.*?\n\s*[€\u20ac](\d+\.\d{2})",
            r"PSO\s+Levy\s+Flat\s+Charge\s*\n\s*[€](\d+\.\d+)",
            r"PSO\s+Levy.*?[€\u20ac]\s*(\d+[\d,.]*\.\d{2})",
            r"Public\s*Service\s*Obligation\s*Levy.*?[€\u20ac](\d+\.\d+)",
        ]),
        Rule("dg_code", 0.9, None, [
            r"(DG\d+)",
        ]),
        Rule("mcc_code", 0.9, None, [
            r"MCC\s*(\d+)",
        ]),
        Rule("subtotal", 0.9, "strip_commas", [
            r"Total\s*Excluding\s*VAT\s*:?\s*~*\s*[€\u20ac]?\s*([\d,]+\.\d{2})",
            r"Sub\s*Total\s*(?:before\s*VAT)?\s*\n?\s*[€\u20ac]([\d,]+\.\d{2})",
        ]),
        Rule("vat_rate", 0.9, None, [
            r"VAT\.?\s*@?\s*(?:on\s*[€\u20ac][\d,.]+\s*at\s*)?(\d+\.?\d*)%",
            r"VAT\.?\s*@?\s*(\d+)\s*%",
        ]),
        Rule("vat_amount", 0.9, "strip_commas", [
            r"VAT\.?\s*@?\s*\d+\.?\d*%\s*[€\u20ac]?\s*([\d,]+\.\d{2})",
            r"VAT\s+on\s+[€\u20ac][\d,.]+\s+at\s+\d+%\s*\n\s*[€\u20ac]([\d,]+\.\d{2})",
        ]),
        Rule("total_incl_vat", 0.9, "strip_commas", [
            r"Total\s*Charges?\s*[Ff]or\s*(?:the|this)\s*Period\s*[€\u20ac]?\s*([\d,]+\.\d{2})",
            r"Total\s+transactions?\s+for\s+this\s+period\s*\n\s*[€\u20ac]([\d,]+\.\d{2})",
        ]),
    ],
    "Go Power": [
        Rule("mprn", 0.95, None, [
            r"MPRN\s*(?:Number|No\.?|:)?\s*[:\s]*(\d{11})",
            r"\b(10\d{9})\b",
        ]),
        Rule("account_number", 0.85, None, [
            r"(?:Account|Acc\.?\s*)\s*(?:Code|Number|No\.?)\s*[:\s]*([A-Z0-9]{3,20})",
        ]),
        Rule("billing_period", 0.9, None, [
            r"(?:Billing|Accounting|Usage)\s*Period\s*[:\s]*(\d{1,2}\s+\w+\s+\d{2,4}\s*(?:to|-)\s*\d{1,2}\s+\w+\s+\d{2,4})",
            r"Usage\s+Period\s+(\d{1,2})\s*-\s*(\d{1,2}/\d{2}/\d{4})",
        ]),
        Rule("invoice_date", 0.85, None, [
            r"Doc\.?\s+Date\s*\n?\s*(\d{2}/\d{2}/\d{4})",
        ]),
        Rule("day_kwh", 0.9, "strip_commas", [
            r"Energy\s+(\d[\d,]*)\s*kWh\s+\d+\.\d+",
            r"Energy\s+Charges\s+Energy\s+(\d[\d,]*)\s*kWh",
        ]),
        Rule("day_rate", 0.85, "cents_to_euros", [
            r"Energy\s+\d[\d,]*\s*kWh\s+(\d+\.\d+)\s*[€\u20ac]",
        ]),
        Rule("day_cost", 0.85, "strip_commas", [
            r"Energy\s+\d[\d,]*\s*kWh\s+\d+\.\d+\s*[€\u20ac](\d[\d,]*\.\d{2})",
        ]),
        Rule("standing_charge", 0.85, None, [
            r"Standing\s+Charge\s+.*?[€\u20ac]\s*(\d+[\d,.]*\.\d{2})",
        ]),
        Rule("pso_levy", 0.8, None, [
            r"PSO\s+Levy.*?[€\u20ac]\s*(\d+[\d,.]*\.\d{2})",
        ]),
        Rule("subtotal", 0.9, "strip_commas", [
            r"(?:Total\s+Excluding\s+VAT|Sub\s*Total)\s*[:\s]*[€\u20ac]?\s*([\d,]+\.\d{2})",
        ]),
        Rule("vat_rate", 0.9, None, [
            r"VAT\s*@?\s*(\d+\.?\d*)%",
        ]),
        Rule("vat_amount", 0.9, "strip_commas", [
            r"VAT\s*@?\s*\d+\.?\d*%\s*[€\u20ac]?\s*([\d,]+\.\d{2})",
        ]),
        Rule("total_incl_vat", 0.9, "strip_commas", [
            r"(?:Total\s+Charges?\s+[Ff]or\s+(?:the|this)\s+Period|NEW\s+BALANCE\s+DUE)\s*[:\s]*[€\u20ac]?\s*([\d,]+\.\d{2})",
            r"Total\s+balance\s+due\s*[€\u20ac]\s*([\d,]+\.\d{2})",
        ]),
    ],
    "ESB Networks": [
        Rule("mprn", 0.95, "strip_spaces", [
            r"MPRN\s*(?:Number|No\.?|:)?\s*[:\s]*(\d{11})",
            r"(10[\s]*\d[\s]*\d[\s]*\d[\s]*\d[\s]*\d[\s]*\d[\s]*\d[\s]*\d[\s]*\d)",
            r"\b(10\d{9})\b",
        ]),
        Rule("account_number", 0.8, None, [
            r"(?:Account|Your\s+account)\s*(?:number|No\.?)\s*[:\s]*(\d{9,10})",
            r"(\d{9,10})\n",
        ]),
        Rule("invoice_number", 0.75, None, [
            r"(?:Invoice|Bill|Doc)\s*(?:No|Number)\.?\s*[:\s]*(\d{10})",
            r"(\d{10})\n",
        ]),
        Rule("billing_period", 0.85, None, [
            r"(?:Billing\s*period|Usage\s*Period)\s*[\s\-]*(\d{1,2}\s+\w+\s+\d{2,4})\s*to\s*(\d{1,2}\s+\w+\s+\d{2,4})",
        ]),
        Rule("standing_charge", 0.85, None, [
            r"Standing\s+Charge\s+([\d.]+)\s+(\d+)\s+days?\s+@\s+[€\u20ac](\d+\.\d+)\s*/\s*day",
        ], groups={"total": 1, "days": 2, "rate": 3}, multi=True),
        Rule("pso_levy", 0.8, None, [
            r"PSO\s+Levy.*?(\d+\.\d+)",
        ]),
        Rule("subtotal", 0.85, "strip_commas", [
            (r"Balance\s+brought\s+forward", r"Charges\s+[€\u20ac]?([\d,]+\.\d{2})"),
            r"Total\s+electricity\s+charges\s+([\d,.]+)",
        ]),
        Rule("vat_rate", 0.9, None, [
            r"VAT\s+\d+\.\d+\s+(\d+)%",
        ]),
        Rule("vat_amount", 0.9, None, [
            (r"Balance\s+brought\s+forward", r"VAT\s+[€\u20ac]?([\d,]+\.\d{2})"),
            r"VAT\s+(\d+\.\d+)\s+\d+%",
        ]),
        Rule("total_incl_vat", 0.85, "strip_commas", [
            r"(?:Total\s+Charges?\s+[Ff]or\s+(?:the|this)\s+Period|Total\s+due)\s*[:\s]*[€\u20ac]?\s*([\d,]+\.\d{2})",
        ]),
        Rule("mcc_code", 0.9, None, [
            r"MCC\s*(\d+)",
        ]),
        Rule("dg_code", 0.9, None, [
            r"(DG\d+)",
        ]),
    ],
    "Kerry Petroleum": [
        Rule("invoice_number", 0.9, None, [
            r"INVOICE\s*(?:No|N[oO0]?)\.?\s*[:\s]*(\d{6})",
        ]),
        Rule("invoice_date", 0.85, None, [
            r"Date[:\s]*(\d{1,2}/\d{1,2}/\d{2,4})",
        ]),
        Rule("litres", 0.85, None, [
            r"KEROSENE\s+(\d{2,4})\s+\d+\.\d{2}",
        ]),
        Rule("unit_price", 0.8, None, [
            r"KEROSENE\s+\d{2,4}\s+(\d+\.\d{2})\s+\d+\.\d{2}",
        ]),
        Rule("subtotal", 0.8, "strip_commas", [
            r"KEROSENE\s+\d{2,4}\s+\d+\.\d{2}\s+(\d+\.\d{2})",
        ]),
        Rule("vat_rate", 0.75, None, [
            r"(\d+\.\d+)\s*%?\s*\d+\.\d{2}\s*\d[\d,]*\.\d{2}\s*$",
            r"KEROSENE\s+\d+\s+\d+\.\d{2}\s+\d+\.\d{2}\s+(\d+\.\d{2})",
        ]),
        Rule("vat_amount", 0.75, None, [
            r"KEROSENE\s+\d+\s+\d+\.\d{2}\s+\d+\.\d{2}\s+\d+\.\d{2}\s+(\d+\.\d{2})",
        ]),
        Rule("total_incl_vat", 0.8, "strip_commas", [
            r"KEROSENE\s+\d+\s+\d+\.\d{2}\s+\d+\.\d{2}\s+\d+\.\d{2}\s+\d+\.\d{2}\s+([\d,]+\.\d{2})",
            r"(?:Total|TOTAL)\s*[:\s]*[€\u20ac]?\s*([\d,]+\.\d{2})",
        ]),
    ],
    "Electric Ireland": [
        Rule("mprn", 0.95, "strip_spaces", [
            r"MPRN\s*(?:Number|No\.?|:)?\s*[:\s]*(\d{11})",
            r"(10[\s]*\d[\s]*\d[\s]*\d[\s]*\d[\s]*\d[\s]*\d[\s]*\d[\s]*\d[\s]*\d)",
            r"\b(10\d{9})\b",
        ]),
        Rule("account_number", 0.85, None, [
            r"Account\s*Number\s*\n\s*(\d{7,10})",
            r"<(\d{9,10})>",
        ]),
        Rule("invoice_number", 0.85, None, [
            r"Invoice\s*(?:No|Number)\.?\s*\n\s*(\d{7,10})",
            r"Invoice\s*(?:No|Number|#)\.?\s*[:\s]+(\d{7,10})",
            (r"Date\s+of\s+issue", r"\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{2,4}\s*\n\s*(\d{9,10})"),
        ]),
        Rule("invoice_date", 0.85, None, [
            r"Date\s+of\s+this\s+Bill\s*\n\s*(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{4})",
            (r"Date\s+of\s+issue", r"(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{2,4})"),
            r"Date\s+of\s+(?:issue|this\s+Bill)\s*[:\s]*(\d{2}/\d{2}/\d{4})",
        ]),
        Rule("billing_period", 0.9, None, [
            r"Billing\s+Period\s*\n\s*(\d{2}/\d{2}/\d{4})\s*[-–]\s*(\d{2}/\d{2}/\d{4})",
            (r"Billing\s+[Pp]eriod", r"(\d{1,2}\s+\w{3,9}\s+\d{2,4})\s+to\s+(\d{1,2}\s+\w{3,9}\s+\d{2,4})"),
        ]),
        Rule("day_kwh", 0.85, "strip_commas", [
            r"Day\s+(\d[\d,.]*)\s+Units?\s+at",
            r"[Cc]onsumption\s+is\s+(\d[\d,]*)\s*kWh",
        ]),
        Rule("day_rate", 0.85, None, [
            r"Day\s+\d[\d,.]*\s+Units?\s+at\s+[€\u20ac](\d+\.\d+)",
            (r"Your\s+electricity\s+usage", r"\d+\s*\n\s*(\d+\.\d{4})\s*\n\s*General"),
        ]),
        Rule("night_kwh", 0.85, "strip_commas", [
            r"Night\s+(\d[\d,.]*)\s+Units?\s+at",
        ]),
        Rule("night_rate", 0.85, None, [
            r"Night\s+\d[\d,.]*\s+Units?\s+at\s+[€\u20ac](\d+\.\d+)",
        ]),
        Rule("peak_kwh", 0.85, "strip_commas", [
            r"Peak\s+(\d[\d,.]*)\s+Units?\s+at",
        ]),
        Rule("peak_rate", 0.85, None, [
            r"Peak\s+\d[\d,.]*\s+Units?\s+at\s+[€\u20ac](\d+\.\d+)",
        ]),
        Rule("standing_charge", 0.85, None, [
            r"Standing\s+Charge\s+(\d+)\s+days?\s+at\s+[€\u20ac](\d+\.\d+)\s+per\s+day\s*\n\s*[€\u20ac](\d+\.\d+)",
            r"Standing\s+Charge\s*\n\s*(\d+\.\d+)\s*\n\s*\d+\s+days?",
        ]),
        Rule("pso_levy", 0.8, None, [
            r"Public\s+Service\s+Obligation\s+Levy.*?\n\s*[€\u20ac](\d+\.\d{2})",
            r"PSO\s+Levy.*?\n\s*(\d+\.\d{2})",
        ]),
        Rule("subtotal", 0.85, "strip_commas", [
            r"Sub\s*Total\s+before\s+VAT\s*\n\s*[€\u20ac]([\d,]+\.\d{2})",
            r"Total\s+electricity\s+charges\s*\n?\s*([\d,]+\.\d{2})",
            r"Charges\s+for\s+this\s+period\s*\n?\s*[€\u20ac]([\d,]+\.\d{2})",
        ]),
        Rule("vat_rate", 0.9, None, [
            r"VAT\s+on\s+[€\u20ac][\d,.]+\s+at\s+(\d+)%",
            r"(\d+)%\s+on\s+[€\u20ac][\d,.]+",
            r"VAT\s+charged\s+at\s+(\d+)%",
        ]),
        Rule("vat_amount", 0.85, "strip_commas", [
            r"VAT\s+on\s+[€\u20ac][\d,.]+\s+at\s+\d+%\s*\n\s*[€\u20ac]([\d,]+\.\d{2})",
            r"^VAT\s*\n\s*[€\u20ac]([\d,]+\.\d{2})",
        ]),
        Rule("total_incl_vat", 0.9, "strip_commas", [
            r"Total\s+transactions?\s+for\s+this\s+period\s*\n\s*[€\u20ac]([\d,]+\.\d{2})",
            r"Total\s+due\s*\n\s*[€\u20ac]([\d,]+\.\d{2})",
            r"Amount\s+due\s*\n?\s*[€\u20ac]([\d,]+\.\d{2})",
        ]),
        Rule("mcc_code", 0.9, None, [
            r"(MCC\d+)",
        ]),
        Rule("dg_code", 0.9, None, [
            r"(DG\d+)",
        ]),
    ],
    "SSE Airtricity": [
        Rule("mprn", 0.95, None, [
            r"MPRN\s*(?:Number|No\.?|:)?\s*[:\s]*(\d{11})",
            r"\b(10\d{9})\b",
        ]),
        Rule("account_number", 0.85, None, [
            r"Account\s*Number\s*[:\s]+(\d{4,10})",
            r"Account\s*Number\s*\n\s*(\d{4,10})",
        ]),
        Rule("invoice_number", 0.8, None, [
            r"Invoice\s*Number\s*[:\s]+(\d+)",
        ]),
        Rule("invoice_date", 0.9, None, [
            r"Date\s+of\s+Issue\s*[:\s]*(\d{2}/\d{2}/\d{4})",
            r"Date\s+of\s+Issue\s*[:\s]*(\d{1,2}\s+\w+\s+\d{4})",
        ]),
        Rule("billing_period", 0.9, None, [
            r"(\d{2}/\d{2}/\d{4})\s+to\s+(\d{2}/\d{2}/\d{4})",
            r"(\d{1,2}\s+\w+\s+\d{4})\s+to\s+(\d{1,2}\s+\w+\s+\d{4})",
        ]),
        Rule("day_kwh", 0.85, "strip_commas", [
            r"SmartSaver\s+Std\s+Day\s*\n\s*(\d+(?:\.\d+)?)",
            r"(?:Day|Standard)\s+(?:Units?|Usage)\s*[:\s]*(\d[\d,.]*)\s*(?:kWh)?",
        ]),
        Rule("day_rate", 0.85, None, [
            r"SmartSaver\s+Std\s+Day\s*\n\s*\d+(?:\.\d+)?\s*\n\s*(\d+\.\d+)",
        ]),
        Rule("night_kwh", 0.85, "strip_commas", [
            r"SmartSaver\s+Std\s+Night\s*\n\s*(\d+(?:\.\d+)?)",
            r"Night\s+(?:Units?|Usage)\s*[:\s]*(\d[\d,.]*)\s*(?:kWh)?",
        ]),
        Rule("night_rate", 0.85, None, [
            r"SmartSaver\s+Std\s+Night\s*\n\s*\d+(?:\.\d+)?\s*\n\s*(\d+\.\d+)",
        ]),
        Rule("standing_charge", 0.85, None, [
            r"Standing\s+Charge.*?\n\s*(\d+(?:\.\d+)?)\s*\n\s*(\d+\.\d+)\s*\n\s*(\d+\.\d+)",
        ]),
        Rule("pso_levy", 0.8, None, [
            (r"PSO\s+Levy", r"(\d+\.\d{2})\s*\n\s*VAT"),
            r"PSO\s+Levy.*?[€\u20ac]\s*(\d+\.\d{2})",
        ]),
        Rule("subtotal", 0.9, None, [
            r"Total\s+costs\s+for\s+this\s+period\s+(\d+\.\d{2})",
        ]),
        Rule("vat_rate", 0.9, None, [
            r"VAT\s*\n?\s*(\d+\.?\d*)%",
        ]),
        Rule("vat_amount", 0.9, None, [
            r"Total\s+VAT\s+(\d+\.\d{2})",
        ]),
        Rule("total_incl_vat", 0.9, None, [
            r"Total\s+charges\s+for\s+this\s+period\s+(\d+\.\d{2})",
            r"TOTAL\s+DUE\s*\n\s*[€\u20ac]\s*(\d[\d,.]+\.\d{2})",
            r"Total\s+Amount\s+Outstanding\s+(\d+\.\d{2})",
        ]),
        Rule("mcc_code", 0.9, None, [
            r"(MCC\d+)",
        ]),
        Rule("dg_code", 0.9, None, [
            r"(DG\d+)",
        ]),
    ],
}

# Text clean-up applied before a provider's rules.
PROVIDER_CLEANUP = {"Energia": "energia", "Kerry Petroleum": "kerry"}

# Provider-independent patterns (regex, confidence, transform) per field.
UNIVERSAL_PATTERNS: dict[str, list[tuple[str, float, str | None]]] = {
    "mprn": [
        (r"(?:MPRN|Meter\s*Point\s*Ref(?:erence)?)\s*(?:No\.?|Number)?\s*[:\-]?\s*(10\d{9})", 0.9, None),
        (r"(10[\s]*\d[\s]*\d[\s]*\d[\s]*\d[\s]*\d[\s]*\d[\s]*\d[\s]*\d[\s]*\d)", 0.75, "strip_spaces"),
        (r"\b(10\d{9})\b", 0.7, None),
    ],
    "gprn": [
        (r"(?:GPRN|Gas\s*Point\s*Reg(?:istration)?)\s*(?:No\.?|Number)?\s*[:\-]?\s*(\d{7})\b", 0.85, None),
    ],
    "account_number": [
        (r"(?:Account|Acct|A/C)\s*(?:Number|No\.?|Code|Num)\s*[:\-]?\s*([\w\-/]{4,20})", 0.8, "strip_spaces"),
        (r"Customer\s*(?:Number|No\.?)\s*[:\-]?\s*([\w\-/]{4,20})", 0.75, "strip_spaces"),
        (r"Client\s*(?:Number|No\.?)\s*[:\-]?\s*([\w\-/]{4,20})", 0.7, "strip_spaces"),
        (r"(?:Your\s+)?account\s*number\s*\n[^\n]*\n\s*(\d{6,10})", 0.7, None),
    ],
    "invoice_number": [
        (r"(?:Invoice|Bill)\s*(?:No\.?|Number|Num)\s*[:\-]?\s*(\d[\w\-/]{3,20})", 0.8, None),
        (r"(?:Reference|Document)\s*(?:No\.?|Number)\s*[:\-]?\s*(\d[\w\-/]{3,20})", 0.7, None),
    ],
    "billing_period": [
        (r"(?:Billing|Bill|Usage|Accounting)\s*[Pp]eriod\s*[:\s]*(\d{1,2}\s+\w+\s+\d{2,4}\s*(?:to|-)\s*\d{1,2}\s+\w+\s+\d{2,4})", 0.85, None),
        (r"(?:Billing|Bill|Accounting)\s*[Pp]eriod\s*\n\s*(\d{1,2}\s+\w+\s+\d{2,4}\s*(?:to|-)\s*\d{1,2}\s+\w+\s+\d{2,4})", 0.85, None),
        (r"(?:Billing|Bill|Accounting)\s*[Pp]eriod\s*[:\s]*(\d{2}/\d{2}/\d{4})\s*[-–]\s*(\d{2}/\d{2}/\d{4})", 0.85, None),
        (r"(?:Billing|Bill|Accounting)\s*[Pp]eriod\s*[:\s]*(\d{2}\.\d{2}\.\d{4})\s*[-–]\s*(\d{2}\.\d{2}\.\d{4})", 0.85, None),
        (r"Billing\s*period\s*\n[^\n]*\n\s*(\d{1,2}\s+\w+\s+\d{2,4}\s+to\s+\d{1,2}\s+\w+\s+\d{2,4})", 0.8, None),
    ],
    "invoice_date": [
        (r"(?:Invoice|Bill)\s*Date\s*[:\-]?\s*(\d{1,2}\s+\w+\s+\d{4})", 0.8, None),
        (r"(?:Invoice|Bill)\s*Date\s*[:\-]?\s*(\d{1,2}/\d{1,2}/\d{2,4})", 0.8, None),
        (r"Date\s*(?:of\s*(?:this\s*)?(?:Invoice|Bill))?\s*[:\-]?\s*(\d{1,2}\s+\w+\s+\d{4})", 0.7, None),
    ],
    "subtotal": [
        (r"Total\s+Excl(?:uding)?\s*VAT\s*[:\s]*[€\u20ac]?\s*([\d,]+\.\d{2})", 0.85, "strip_commas"),
        (r"Sub\s*[Tt]otal\s*(?:before\s*VAT)?\s*[:\s]*[€\u20ac]?\s*([\d,]+\.\d{2})", 0.85, "strip_commas"),
        (r"Net\s+(?:Total|Amount)\s*[:\s]*[€\u20ac]?\s*([\d,]+\.\d{2})", 0.8, "strip_commas"),
        (r"(?:Total|Amount)\s+(?:Ex|Before)\s*VAT\s*[:\s]*[€\u20ac]?\s*([\d,]+\.\d{2})", 0.8, "strip_commas"),
        (r"VAT\s+\d+%\s+on\s+[€\u20ac]([\d,]+\.\d{2})", 0.75, "strip_commas"),
        (r"Total\s+electricity\s+charges\s+(\d[\d,]*\.\d{2})", 0.7, "strip_commas"),
    ],
    "vat_rate": [
        (r"(?:VAT|V\.A\.T\.?)\s*(?:@|at)?\s*(\d{1,2}(?:\.\d{1,2})?)\s*%", 0.85, None),
        (r"VAT\s+\d+\.\d+\s+(\d+)%", 0.8, None),
    ],
    "vat_amount": [
        (r"(?:VAT|V\.A\.T\.?)\s*\d{1,2}(?:\.\d{1,2})?\s*%\s+on\s+[€\u20ac]?[\d,]+\.\d{2}\s+([\d,]+\.\d{2})", 0.9, "strip_commas"),
        (r"(?:VAT|V\.A\.T\.?)\s*(?:@|at)?\s*\d{1,2}(?:\.\d{1,2})?\s*%\s*[^\d]*?[€\u20ac]?\s*([\d,]+\.\d{2})", 0.85, "strip_commas"),
        (r"VAT\s+(\d+\.\d{2})\s+\d+%", 0.8, "strip_commas"),
        (r"VAT\s+\d+%\s+on\s+[€\u20ac]?[\d,]+\.\d{2}\s+(\d[\d,]*\.\d{2})\s*$", 0.8, "strip_commas"),
    ],
    "total_incl_vat": [
        (r"Total\s+(?:Charges?\s+)?(?:[Ff]or\s+)?(?:[Tt]h(?:is|e)\s+[Pp]eriod)\s*[:\s]*[€\u20ac]?\s*([\d,]+\.\d{2})", 0.85, "strip_commas"),
        (r"(?:Amount|Balance)\s+Due\s*[:\s]*[€\u20ac]?\s*([\d,]+\.\d{2})", 0.8, "strip_commas"),
        (r"(?:Grand|Invoice)\s+Total\s*[:\s]*[€\u20ac]?\s*([\d,]+\.\d{2})", 0.8, "strip_commas"),
        (r"Total\s+(?:Inc(?:luding|l\.?)\s*VAT)\s*[:\s]*[€\u20ac]?\s*([\d,]+\.\d{2})", 0.8, "strip_commas"),
        (r"NEW\s+BALANCE\s+DUE\s*[:\s]*[€\u20ac]?\s*([\d,]+\.\d{2})", 0.75, "strip_commas"),
        (r"Total\s+(?:due|balance\s+due)\s*[:\s]*[€\u20ac]?\s*([\d,]+\.\d{2})", 0.75, "strip_commas"),
    ],
    "day_kwh": [
        (r"Day\s+(?:Energy|Rate)\s+(\d[\d,]*)\s*(?:kWh|xWh)", 0.8, "strip_commas"),
        (r"Energy\s+(\d[\d,]*)\s*kWh\s+\d+\.\d+", 0.7, "strip_commas"),
        (r"\b(\d{3,5})\s+\d+\.\d{3,4}\s+General", 0.7, "strip_commas"),
    ],
    "day_rate": [
        (r"Day\s+(?:Energy|Rate)\s+\d[\d,]*\s*(?:kWh|xWh)\s*@\s*[€\u20ac]?\s*(\d+\.\d+)", 0.8, None),
        (r"Energy\s+\d[\d,]*\s*kWh\s+(\d+\.\d+)\s*[€\u20ac]", 0.7, None),
        (r"\b\d{3,5}\s+(\d+\.\d{3,4})\s+General", 0.7, None),
    ],
    "night_kwh": [
        (r"Night\s+(?:Energy|Rate)\s+(\d[\d,]*)\s*(?:kWh|xWh)", 0.8, "strip_commas"),
    ],
    "night_rate": [
        (r"Night\s+(?:Energy|Rate)\s+\d[\d,]*\s*(?:kWh|xWh)\s*@\s*[€\u20ac]?\s*(\d+\.\d+)", 0.8, None),
    ],
    "standing_charge": [
        (r"Standing\s*Charge\s*.{0,80}?[€\u20ac]\s*(\d+[\d,.]*\.\d{2})", 0.75, "strip_commas"),
        (r"Standing\s*Charge\b[^\n]*?(\d+\.\d{2})\s*$", 0.7, "strip_commas"),
    ],
    "pso_levy": [
        (r"PSO\s+Levy\b[^\n]*?(\d[\d,]*\.\d{2})\s*$", 0.75, "strip_commas"),
        (r"PSO\s+Levy.*?[€\u20ac]?\s*(\d+[\d,.]*\.\d{2})", 0.7, None),
        (r"Public\s*Service\s*Obligation\s*Levy.*?[€\u20ac](\d+\.\d+)", 0.65, None),
    ],
    "litres": [
        (r"(?:KEROSENE|[Hh]eating\s*[Oo]il|[Gg]as\s*[Oo]il)\s+(\d{2,5})\s+\d+\.\d{2}", 0.75, None),
    ],
    "unit_price": [
        (r"(?:KEROSENE|[Hh]eating\s*[Oo]il|[Gg]as\s*[Oo]il)\s+\d{2,5}\s+(\d+\.\d{2})\s+\d+\.\d{2}", 0.7, None),
    ],
    "mcc_code": [
        (r"MCC\s*(\d+)", 0.85, None),
    ],
    "dg_code": [
        (r"(DG\d+)", 0.85, None),
    ],
}

# Keywords that name a provider; earlier providers win ties.
PROVIDER_KEYWORDS = {
    "Electric Ireland": ["electric ireland", "electricireland.ie", "electricireland", "myelectricireland"],
    "SSE Airtricity": ["sse airtricity", "airtricity", "sseairtricity.com"],
    "Bord Gais": ["bord gáis", "bord gais", "bordgais", "bordgaisenergy.ie"],
    "Kerry Petroleum": ["kerry petroleum"],
    "Energia": ["energia", "energia.ie", "632 6035", "generali building"],
    "ESB Networks": ["esb networks", "esb network"],
    "Go Power": ["go power", "gopower", "gopower.ie"],
    "Flogas": ["flogas", "flogas.ie"],
    "Calor Gas": ["calor gas", "calor"],
    "Pinergy": ["pinergy", "pinergy.ie"],
    "Prepay Power": ["prepay power", "prepaypower"],
    "Panda Power": ["panda power", "pandapower.ie"],
    "Bright": ["bright energy"],
    "Community Power": ["community power"],
    "Iberdrola": ["iberdrola"],
    "Yuno Energy": ["yuno", "yunoenergy.ie"],
}

# Bill type per provider.
PROVIDER_BILL_TYPE = {
    "Energia": "electricity",
    "Go Power": "electricity",
    "ESB Networks": "electricity",
    "Electric Ireland": "electricity",
    "SSE Airtricity": "electricity",
    "Bord Gais": "gas",
    "Flogas": "fuel",
    "Kerry Petroleum": "fuel",
    "Calor Gas": "fuel",
    "Pinergy": "electricity",
    "Prepay Power": "electricity",
    "Panda Power": "electricity",
    "Bright": "electricity",
    "Community Power": "electricity",
    "Iberdrola": "electricity",
    "Yuno Energy": "electricity",
}

# Supplier signatures for the weighted detection.
SUPPLIER_SIGNATURES = {
    "Energia": {"keywords": ["energia", "energia.ie"], "phone": ["0818 405 405", "1800 372 999"], "vat": "632 6035", "address": "Generali Building"},
    "Electric Ireland": {"keywords": ["Electric Ireland", "electricireland.ie"], "phone": ["1850 372 372", "0818 372 372"], "vat": "983 8858", "address": "South County Business Park"},
    "SSE Airtricity": {"keywords": ["SSE Airtricity", "sseairtricity.com"], "phone": ["1850 812 812", "0818 222 991"], "vat": "", "address": "Red Oak South"},
    "Bord Gais Energy": {"keywords": ["Bord Gais", "Bord Gáis", "bordgaisenergy.ie"], "phone": ["1850 632 632", "0818 200 989"], "vat": "", "address": "Warrington Place"},
    "Panda Power": {"keywords": ["Panda Power", "pandapower.ie"], "phone": [], "vat": "", "address": ""},
    "Yuno Energy": {"keywords": ["Yuno", "yunoenergy.ie"], "phone": [], "vat": "", "address": ""},
    "Flogas": {"keywords": ["Flogas", "flogas.ie"], "phone": [], "vat": "", "address": ""},
    "Pinergy": {"keywords": ["Pinergy", "pinergy.ie"], "phone": [], "vat": "", "address": ""},
}

# Labels printed beside a value, most specific first.
ANCHOR_LABELS = {
    "total_incl_vat": ["Total Charges For This Period", "Total Charges for the Period", "Total transactions for this period", "Total Including VAT", "Total incl VAT", "Amount Due", "Grand Total", "Total due", "NEW BALANCE DUE"],
    "subtotal": ["Total Excluding VAT", "Total Excl VAT", "Sub Total before VAT", "SubTotal", "Sub Total", "Net Total", "Net Amount", "Total electricity charges"],
    "vat_rate": ["VAT @", "VAT at", "V.A.T.", "VAT"],
    "vat_amount": ["VAT on", "VAT @", "VAT at", "V.A.T.", "VAT"],
    "mprn": ["Meter Point Reference Number", "Meter Point Reference", "MPRN Number", "MPRN No", "MPRN"],
    "gprn": ["Gas Point Registration", "GPRN Number", "GPRN No", "GPRN"],
    "account_number": ["Account Number", "Account No", "Account Code", "Acct No", "A/C No"],
    "invoice_number": ["Invoice Number", "Invoice No", "Bill Number", "Bill No"],
    "billing_period": ["Billing Period", "Bill Period", "Usage Period", "Accounting Period"],
    "invoice_date": ["Date of this Bill", "Invoice Date", "Bill Date"],
    "day_kwh": ["Day Energy", "Day Rate"],
    "day_rate": ["Day Energy", "Day Rate"],
    "night_kwh": ["Night Energy", "Night Rate"],
    "night_rate": ["Night Energy", "Night Rate"],
    "standing_charge": ["Standing Charge"],
    "pso_levy": ["PSO Levy", "Public Service Obligation Levy"],
    "litres": ["KEROSENE", "Heating Oil", "Gas Oil"],
    "unit_price": ["KEROSENE", "Heating Oil", "Gas Oil"],
    "mcc_code": ["MCC"],
    "dg_code": ["DG"],
}

# Value types a field may have and their shapes.
VALUE_TYPE_PATTERNS = {
    "monetary": r"[€]?\d[\d,]*\.\d{2}$",
    "integer": r"\d{3,}$",
    "percentage": r"\d{1,2}(?:\.\d+)?%$",
    "date": r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}$",
    "alphanumeric": r"[\w\-/]{4,20}$",
}
# Expected value types per field.
FIELD_VALUE_TYPES = {
    "total_incl_vat": ["monetary"],
    "subtotal": ["monetary"],
    "vat_rate": ["percentage", "integer"],
    "vat_amount": ["monetary"],
    "mprn": ["integer"],
    "gprn": ["integer"],
    "account_number": ["integer", "alphanumeric"],
    "invoice_number": ["integer", "alphanumeric"],
    "billing_period": ["date", "alphanumeric"],
    "invoice_date": ["date", "alphanumeric"],
    "day_kwh": ["integer"],
    "day_rate": ["monetary"],
    "night_kwh": ["integer"],
    "night_rate": ["monetary"],
    "standing_charge": ["monetary"],
    "pso_levy": ["monetary"],
    "litres": ["integer"],
    "unit_price": ["monetary"],
    "mcc_code": ["integer", "alphanumeric"],
    "dg_code": ["alphanumeric"],
}
