"""The answers that models are asked for: one DDL schema each, and the JSON schema that is sent along, made from it."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, NumericType, StructType

from ..functions import patterns as P

_ELEMENT = "array<struct<value:string,normalized:string,role:string,clause_id:string,source_text:string,confidence:double>>"
DDL = {
    "contract_element_extraction": "struct<" + ",".join(f"{k}:{_ELEMENT}" for k in ("parties", "amounts", "dates", "subjects")) + ">",
    "contract_consistency_review": "struct<findings:array<struct<code:string,severity:string,message:string,evidence:string,clause_ids:array<string>,confidence:double>>>",
    "contract_understanding": "struct<contract_type:string,subject_summary:string,payment_summary:string,key_obligations:array<string>,clause_roles:array<struct<clause_id:string,role:string>>>",
    "clause_risk_review": "struct<risks:array<struct<code:string,severity:string,clause_id:string,reason:string,evidence:string>>>",
    "cross_clause_conflict_review": "struct<conflicts:array<struct<code:string,severity:string,clause_ids:array<string>,reason:string,evidence:string>>>",
    "legal_application_verdict": "struct<verdicts:array<struct<candidate_id:string,assessment:string,severity:string,reason:string,article_uid:string,quote:string>>>",
    "final_adjudication": "struct<verdicts:array<struct<candidate_id:string,keep:boolean,severity:string,review_required:boolean,rationale:string>>,overall_assessment:string,overall_score:int,summary:string>",
    "cross_module_arbitration": "struct<conflicts:array<struct<type:string,description:string,involved_ids:array<string>,resolution:string>>,has_material_conflict:boolean>",
    "contract_clause_split": "struct<clauses:array<struct<label:string,title:string,level:int,block_ids:array<string>,confidence:double>>>",
    "contract_boundary_review": "struct<boundaries:array<struct<boundary_id:string,relation:string,confidence:double,right_block_role:string,inferred_title:string,reason:string>>>",
}
FINDING_CODES = ("amount_conflict", "date_conflict", "party_conflict", "reference_conflict", "semantic_conflict")
RELATIONS = ("CONTINUATION", "SAME_CLAUSE", "NEW_SUBCLAUSE", "NEW_CLAUSE")
ROLES = ("TITLE", "BODY", "LIST_ITEM", "UNKNOWN")
CONFLICT_TYPES = ("severity_mismatch", "type_mismatch", "element_contradiction", "mutual_exclusion")
#: Fields whose values are given: by schema and field, or by field for all schemas.
CHOICES = {
    "severity": tuple(P.SEVERITY_RANK),
    "assessment": tuple(P.ASSESSMENTS),
    "relation": RELATIONS,
    "right_block_role": ROLES,
    ("contract_consistency_review", "code"): FINDING_CODES,
    ("cross_module_arbitration", "type"): CONFLICT_TYPES,
}


def struct_of(name: str) -> StructType:
    return StructType.fromDDL(DDL[name].removeprefix("struct<").removesuffix(">"))


def json_schema(name: str) -> dict:
    """Strict: every field is required and no other is allowed; confidences lie in 0 to 1."""

    def of(kind: DataType, field: str) -> dict:
        if isinstance(kind, StructType):
            return {"type": "object", "properties": {f.name: of(f.dataType, f.name) for f in kind}, "required": kind.names, "additionalProperties": False}
        if isinstance(kind, ArrayType):
            return {"type": "array", "items": of(kind.elementType, "")}
        if isinstance(kind, BooleanType):
            return {"type": "boolean"}
        if isinstance(kind, NumericType):
            return {"type": "integer" if isinstance(kind, IntegralType) else "number"} | ({"minimum": 0, "maximum": 1} if field == "confidence" else {})
        choices = CHOICES.get((name, field)) or CHOICES.get(field)
        return {"type": "string"} | ({"enum": list(choices)} if choices else {})

    return of(struct_of(name), "")
