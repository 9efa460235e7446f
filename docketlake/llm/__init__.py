"""Training-data operators on notice text: one module per operator, registered queries in ``queries``."""
