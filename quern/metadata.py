"""What a catalog's selectors offer: the EDMX schema and the service document."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any
from xml.etree import ElementTree as ET

from pyspark.sql import types as T

from .catalog import public
from .selector import Selector

#: Spark types in the EDM: fixed values.
EDM = {
    T.ByteType: "Edm.SByte", T.ShortType: "Edm.Int16", T.IntegerType: "Edm.Int32", T.LongType: "Edm.Int64", T.FloatType: "Edm.Single", T.DoubleType: "Edm.Double", T.DecimalType: "Edm.Decimal", T.StringType: "Edm.String",
    T.BooleanType: "Edm.Boolean", T.DateType: "Edm.Date", T.TimestampType: "Edm.DateTimeOffset", T.TimestampNTZType: "Edm.DateTimeOffset", T.DayTimeIntervalType: "Edm.Duration", T.BinaryType: "Edm.Binary",
}


def edm(t: T.DataType) -> str:
    return f"Collection({edm(t.elementType)})" if isinstance(t, T.ArrayType) else EDM.get(type(t), "Edm.String")


def service_document(selectors: Mapping[str, Selector], url: str = "") -> dict[str, Any]:
    return {"@odata.context": f"{url}/$metadata", "value": [{"name": n, "kind": "EntitySet", "url": n} for n in sorted(selectors)]}


def edmx(selectors: Mapping[str, Selector], namespace: str = "Default") -> str:
    """The schema of entity sets by name. Private columns and what a policy doesn't allow are left out; an empty allow-list means that nothing may be used."""
    root = ET.Element("edmx:Edmx", {"Version": "4.0", "xmlns:edmx": "http://docs.oasis-open.org/odata/ns/edmx"})
    schema = ET.SubElement(ET.SubElement(root, "edmx:DataServices"), "Schema", {"Namespace": namespace, "xmlns": "http://docs.oasis-open.org/odata/ns/edm"})
    sets = {s.entity.name: n for n, s in selectors.items()}
    container = ET.Element("EntityContainer", {"Name": "Container"})
    for name in sorted(selectors):
        selector = selectors[name]
        entity, policy = selector.entity, selector.policy
        kind = ET.SubElement(schema, "EntityType", {"Name": entity.name})
        if entity.pk:
            key = ET.SubElement(kind, "Key")
            for c in entity.pk:
                ET.SubElement(key, "PropertyRef", {"Name": c})
        names = {t: a for a, t in policy.aliases.items()}
        for f in entity.source().schema.fields:
            api = names.get(f.name, f.name)
            if public(f.name) and (policy.allowed_fields is None or api in policy.allowed_fields or f.name in policy.allowed_fields or f.name in entity.pk):
                ET.SubElement(kind, "Property", {"Name": api, "Type": edm(f.dataType), "Nullable": str(f.name not in entity.pk).lower()})
        entity_set = ET.SubElement(container, "EntitySet", {"Name": name, "EntityType": f"{namespace}.{entity.name}"})
        for relation, r in entity.relations.items():
            if r.target in sets and (policy.expandable is None or relation in policy.expandable):
                target = f"{namespace}.{r.target}"
                ET.SubElement(kind, "NavigationProperty", {"Name": relation, "Type": target if r.kind == "forward" else f"Collection({target})"})
                ET.SubElement(entity_set, "NavigationPropertyBinding", {"Path": relation, "Target": sets[r.target]})
        for term, allowed, denied in (("FilterRestrictions", policy.filterable, policy.not_filterable), ("SortRestrictions", policy.sortable, policy.not_sortable)):
            if allowed is not None or denied:
                note = ET.SubElement(entity_set, "Annotation", {"Term": f"Org.OData.Capabilities.V1.{term}"})
                record = ET.SubElement(note, "Record")
                for what, fields in (("Allowed", allowed), ("Denied", denied or None)):
                    if fields is not None:
                        listed = ET.SubElement(ET.SubElement(record, "PropertyValue", {"Property": f"{what}Properties"}), "Collection")
                        for f in fields:
                            ET.SubElement(listed, "PropertyPath").text = f
    schema.append(container)
    return ET.tostring(root, encoding="unicode", xml_declaration=True)
