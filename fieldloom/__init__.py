"""Contracts for form-like documents, on Spark.

Templates become a table of fields and rules; documents are checked against it, brought into
the layouts of other systems and compared field by field.
"""

from fieldloom.plans.layout import QUESTIONNAIRE, FieldType, Level, PropertyNames
from fieldloom.plans.layout import TargetRule, TemplateLayout

__all__ = [
    "QUESTIONNAIRE",
    "FieldType",
    "Level",
    "PropertyNames",
    "TargetRule",
    "TemplateLayout",
]
