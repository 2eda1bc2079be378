"""IRIs that the derivations look for, and the fields that exports leave out."""

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
OBO = "http://purl.obolibrary.org/obo/"
OIO = "http://www.geneontology.org/formats/oboInOwl#"
DC, DCT = "http://purl.org/dc/elements/1.1/", "http://purl.org/dc/terms/"

TYPE, FIRST, REST, NIL = RDF + "type", RDF + "first", RDF + "rest", RDF + "nil"
SUBCLASS, SUBPROPERTY, LABEL = RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "label"
THING, TOP_PROPERTY, NAMED_INDIVIDUAL = OWL + "Thing", OWL + "TopObjectProperty", OWL + "NamedIndividual"
PART_OF = OBO + "BFO_0000050"
PREFERRED_ROOT = (OBO + "IAO_0000700",)
OBSOLETE_CLASS, DEPRECATED = OIO + "ObsoleteClass", OWL + "deprecated"
LABELS = (LABEL, SKOS + "prefLabel", DC + "title", DCT + "title")
DEFINITIONS = (RDFS + "comment", OBO + "IAO_0000115", DCT + "description", DC + "description")
SYNONYMS = tuple(OIO + f"has{k}Synonym" for k in ("Broad", "Exact", "Narrow", "Related")) + (OIO + "hasSynonym",)

#: rdf:type object -> node types.
NODE_TYPES = {
    OWL + "Ontology": ("ontology",),
    OWL + "Class": ("class",),
    RDFS + "Class": ("class",),
    SKOS + "Concept": ("class",),
    OWL + "AnnotationProperty": ("annotationProperty", "property"),
    OWL + "ObjectProperty": ("objectProperty", "property"),
    OWL + "DatatypeProperty": ("dataProperty", "property"),
    RDF + "Property": ("property",),
    NAMED_INDIVIDUAL: ("individual",),
    OWL + "Axiom": ("axiom",),
    OWL + "Restriction": ("restriction",),
    OWL + "AllDisjointClasses": ("allDisjointClasses",),
    OWL + "AllDisjointProperties": ("allDisjointProperties",),
    OWL + "AllDifferent": ("allDifferent",),
    OWL + "NegativePropertyAssertion": ("negativePropertyAssertion",),
    RDFS + "Datatype": ("datatype",),
}
ENTITY_TYPES = ("class", "property", "individual")
#: Not exported: properties, and edges.
HIDDEN_PROPERTIES = ("appearsIn", "searchableAnnotationValues")
HIDDEN_EDGES = ("iri", "hierarchicalProperty", "definitionProperty", "synonymProperty", "directAncestor", "hierarchicalAncestor", "relatedFrom")
