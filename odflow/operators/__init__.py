"""DataFrame operators, one module per family (see the README's inventory).

``codebook`` (C), ``filters`` (F), ``crosstab`` (A1, W1, F10), ``locate`` (J8, J9, J14),
``geometry_layer`` (S3, G3, G4), ``flows`` (A2, A3, A8, A9, U2, P14, J10, G2), ``selection``
(Q4, A6, A11), ``segments`` (J13, J4, A4, D1), ``panel`` (Q6), ``density`` (A13-A15),
``lines`` (G1, P15, W2), ``joins`` (J1, J2, J7, J11), ``clean`` (P2, P8-P12) and
``quantile`` (exact order statistics and global ranks without a single-task merge).
"""
