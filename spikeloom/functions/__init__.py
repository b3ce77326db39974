"""Coefficients and small numeric helpers; nothing here touches data at rest."""
